import sys

from ctxspark.cli import main

sys.exit(main())
