"""parlance.streaming"""
