"""parlance.operators"""
