"""Plan-shape helpers: written tables, checked broadcasts, chunked windows, distributed ranks."""
