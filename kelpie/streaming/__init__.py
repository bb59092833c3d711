"""kelpie.streaming"""
