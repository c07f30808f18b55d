"""terraweave.streaming"""
