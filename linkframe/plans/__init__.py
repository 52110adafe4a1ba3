"""linkframe.plans"""
