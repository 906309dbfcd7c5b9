"""Plans: whole analyses composed of operators."""
