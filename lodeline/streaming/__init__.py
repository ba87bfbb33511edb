"""lodeline.streaming"""
