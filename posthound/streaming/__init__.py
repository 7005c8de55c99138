"""posthound.streaming"""
