"""End-to-end jobs made of the operators: building panel, company panel, experiments."""
