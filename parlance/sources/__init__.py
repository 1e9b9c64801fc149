"""parlance.sources"""
