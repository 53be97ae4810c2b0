"""Where rows come from: stored HTML, JSON artifacts, and the dimension tables."""
