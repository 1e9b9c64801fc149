"""parlance.llm"""
