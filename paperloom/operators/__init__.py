"""paperloom.operators"""
