import sys

from graphloom.cli import main

sys.exit(main())
