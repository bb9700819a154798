"""Run every registered query once and print rows / seconds / errors (dev tool)."""
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from harborline.plans.registry import queries  # noqa: E402
from harborline.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
spark = local_session()
for name, fn in queries().items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        n = fn(spark, sf).count()
        print(f"OK   {name:28s} rows={n:<8d} {time.time() - t:6.1f}s", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {name:28s} {type(e).__name__}: {str(e).splitlines()[0][:300]}", flush=True)
        traceback.print_exc(limit=3, file=sys.stderr)
