"""ravelin.sources"""
