"""posthound.functions"""
