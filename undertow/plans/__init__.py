"""undertow.plans"""
