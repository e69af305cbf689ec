"""labelscope.plans"""
