"""labelscope.functions"""
