"""terraweave.queries"""
