"""Column functions: kinematics, rotations, spatial keys and time. All are expressions that stay in the JVM."""
