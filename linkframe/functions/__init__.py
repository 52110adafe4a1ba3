"""linkframe.functions"""
