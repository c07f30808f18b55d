"""terraweave.plans"""
