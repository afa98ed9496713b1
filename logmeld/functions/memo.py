"""Column expressions that are built once a session and used in any number of plans.

A large expression is thousands of calls from Python to the JVM. Columns are immutable and hold names only, so the same ones serve every later
plan, such as those of each micro-batch.
"""

from functools import wraps

from pyspark import SparkContext

LIMIT = 64


def remembered(build):
    """The function with its results kept by its arguments, as long as the JVM is the same. Arguments that cannot be keys are not kept."""
    known: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        try:
            found = known.get(key)
        except TypeError:
            return build(*args)
        if found is None:
            if len(known) >= LIMIT:
                known.clear()
            found = known[key] = build(*args)
        return found

    return get
