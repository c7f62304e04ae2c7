"""Run with python -m maillake."""

import sys

from maillake.cli import main

sys.exit(main())
