"""linkframe.sources"""
