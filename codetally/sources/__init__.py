"""Where rows come from: source trees on a file system, constant dimensions."""
