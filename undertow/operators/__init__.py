"""undertow.operators"""
