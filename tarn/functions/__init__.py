"""tarn.functions"""
