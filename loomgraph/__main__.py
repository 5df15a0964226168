import sys

from loomgraph.api import main

sys.exit(main())
