"""posthound.sources"""
