"""linkframe.operators"""
