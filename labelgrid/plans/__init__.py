"""Driver-side descriptions that decide a plan before any job runs."""
