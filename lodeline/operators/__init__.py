"""lodeline.operators"""
