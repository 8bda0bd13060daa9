"""custodia: file-governance analytics on Spark.

Every operator takes DataFrames and returns DataFrames; nothing keeps session state.

* ``functions``  column functions (typing, naming, text)
* ``sources``    reading and writing files, exports, snapshots and keyed tables
* ``operators``  joins, aggregations, policies, vector search
* ``plans``      jobs composed of the above
* ``streaming``  the same jobs over arriving files
* ``registered`` the queries checked against SQL, and that SQL
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
