"""terraweave.functions"""
