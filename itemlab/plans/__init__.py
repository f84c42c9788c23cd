"""Plan shapes shared by the operators: staging, ranks without a global sort, hot groups."""
