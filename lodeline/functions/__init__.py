"""lodeline.functions"""
