from confluo.plans.cli import main

raise SystemExit(main())
