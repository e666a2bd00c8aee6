"""Calendar-exact indicator and event analytics as Spark DataFrame jobs.

Three rules run through the package:

* missing is not zero: a total over an incomplete window is NULL;
* a calendar lag is not a row lag: last year's value is found by its period;
* incomplete trailing periods are cut before period statistics.
"""

from periodica.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
__version__ = "0.1.0"
