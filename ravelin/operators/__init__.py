"""ravelin.operators"""
