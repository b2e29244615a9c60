"""graphloom.functions"""
