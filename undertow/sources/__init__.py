"""undertow.sources"""
