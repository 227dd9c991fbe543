"""Command line of mnemospark."""

import sys

from .sources.service import main

sys.exit(main())
