"""terraweave.sources"""
