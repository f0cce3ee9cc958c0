"""Plans: batch jobs, backend and policy resolution, routing between sources, cover planning."""
