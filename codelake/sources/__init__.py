"""Where bytes come from: files, containers, headers."""
