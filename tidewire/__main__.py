"""Runs an entry point from the command line."""

from __future__ import annotations

import sys

from tidewire.pipeline import main

sys.exit(main())
