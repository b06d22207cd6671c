import sys

from quillcheck.plans.audit import main

sys.exit(main())
