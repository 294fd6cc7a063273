"""Column functions: every one returns a Spark Column and stays inside the JVM."""

from emipanel.functions.core import as_col, hash32, nan_to_null
from emipanel.functions.geo import *  # noqa: F401,F403
from emipanel.functions.numeric import *  # noqa: F401,F403
from emipanel.functions.text import *  # noqa: F401,F403
