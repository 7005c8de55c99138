"""posthound.operators"""
