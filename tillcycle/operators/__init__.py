"""Operators: DataFrame -> DataFrame building blocks of the operating cycle."""
