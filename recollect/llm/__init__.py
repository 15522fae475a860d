"""Training-data operators: each module is one operator; `entry` registers its query."""
