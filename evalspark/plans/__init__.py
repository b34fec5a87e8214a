"""Complete jobs: score report, leaderboard, backlog, classifier probe."""
