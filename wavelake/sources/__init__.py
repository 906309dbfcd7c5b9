"""Sources: sensor files, label files, session folders, JSON archives, logs."""
