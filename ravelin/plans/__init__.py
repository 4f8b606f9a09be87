"""ravelin.plans"""
