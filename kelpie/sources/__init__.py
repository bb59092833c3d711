"""kelpie.sources"""
