"""undertow.functions"""
