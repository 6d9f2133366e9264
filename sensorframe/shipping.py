"""Sends this package to the executors, whose Python workers may start in any folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED = "spark.sensorframe.shipped"


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the session, once for each application.

    Functions that run in Python workers are sent by name, so the workers have to import this package.
    """
    application = spark.sparkContext.applicationId
    if spark.conf.get(_SHIPPED, "") == application:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sensorframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(_PACKAGE)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(target)
    spark.conf.set(_SHIPPED, application)
