"""cropframe: crop-yield and climate analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers for landed files and the driver-table bindings, synthetic generators, sinks
functions  column expressions (agro-climate formulas, calendar tables, formatting)
operators  DataFrame -> DataFrame operators (spatial, temporal, features, integration,
           analysis, modelling, scenarios)
plans      composite chains and the registered query catalogue
streaming  file-stream variants of the batch operators
"""

__version__ = "0.1.0"
