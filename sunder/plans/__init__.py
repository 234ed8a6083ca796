"""Building blocks shared by operators: scratch tables, graph algorithms, group assignment."""
