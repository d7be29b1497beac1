"""Read-side plans: listings, details, statistics, series and feeds."""
