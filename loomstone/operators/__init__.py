"""loomstone.operators"""
