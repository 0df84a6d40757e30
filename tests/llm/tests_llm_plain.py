"""Plain versions shared by the tests."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_operators import plain_contamination, plain_groups, sentence  # noqa: E402, F401
