"""loomstone.functions"""
