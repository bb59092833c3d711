"""kelpie.functions"""
