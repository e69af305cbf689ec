"""labelscope.streaming"""
