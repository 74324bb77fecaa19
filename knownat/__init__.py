"""Point-in-time equity analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames.  Nothing is collected to
the driver; ordered work is split on a key *and* a time bucket so that no single
key decides how long a job runs (see ``knownat.functions.ordered``).
"""

__version__ = "0.1.0"
