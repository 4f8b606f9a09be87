"""ravelin.functions"""
