"""factloom.sources"""
