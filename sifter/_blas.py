"""Keep BLAS single-threaded per process.

Spark already runs one task per core; a multi-threaded BLAS inside the
driver or each Python worker oversubscribes the cores (and with the JVM in
the same machine it can stall).  The variables cover libraries loaded later;
an already loaded OpenBLAS is switched through its C entry point.
"""

from __future__ import annotations

import ctypes
import glob
import os

for _var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_var, "1")


def limit_loaded_blas() -> None:
    try:
        import numpy
    except ImportError:  # pragma: no cover
        return
    libdir = os.path.join(os.path.dirname(numpy.__file__), os.pardir, "numpy.libs")
    for path in glob.glob(os.path.join(libdir, "*openblas*")):
        try:
            lib = ctypes.CDLL(path)
        except OSError:
            continue
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_",
                     "openblas_set_num_threads"):
            fn = getattr(lib, name, None)
            if fn is not None:
                fn(1)
                break


limit_loaded_blas()
