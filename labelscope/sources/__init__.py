"""labelscope.sources"""
