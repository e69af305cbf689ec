"""labelscope.operators"""
