"""undertow.streaming"""
