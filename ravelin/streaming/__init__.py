"""ravelin.streaming"""
