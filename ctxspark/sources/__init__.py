"""Sources: source trees, git history, reports, requirement exports, configuration."""
