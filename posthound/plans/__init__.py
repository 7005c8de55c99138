"""posthound.plans"""
