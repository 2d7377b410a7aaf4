"""itemscope: Spark-native analytics over benchmark evaluation logs.

Every operator is a function from DataFrames (plus plain arguments) to a
DataFrame.  Sub-packages:

* ``sources``   - fixture tables derived from the test data, readers/writers
* ``functions`` - column-expression helpers (softmax on arrays, md5 order, ...)
* ``operators`` - ETL, splits, item statistics, selection, IRT, estimators,
                  metrics and result tables
* ``plans``     - end-to-end pipelines composed from the operators
* ``streaming`` - incremental disagreement and windowed accuracy
"""

from itemscope.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
