"""kelpie.operators"""
