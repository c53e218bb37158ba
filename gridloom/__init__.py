"""gridloom: raster and grid analytics as Spark DataFrame work.

Every operator takes and returns DataFrames.  The central table is the *plane*:
``(image_id long, ch int, y int, x int, v double)``, dense within each image.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to executors with their code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
