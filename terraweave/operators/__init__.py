"""terraweave.operators"""
