"""Meridia: retrieval, answer-quality and serving analytics on PySpark.

Every public function takes and returns DataFrames. Operators declare a
logical plan and leave the physical strategy to Catalyst; nothing collects a
data-sized result to the driver.
"""
